"""touchline: match analytics on Spark, and operators for preparing training corpora (touchline.llm)."""
