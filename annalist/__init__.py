"""annalist: evaluating how well retrieval and RAG systems handle time, on Spark DataFrames."""
