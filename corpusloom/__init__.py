"""corpusloom: a Spark-native engine for building and analysing language-model corpora."""
