"""PySpark-native engine for building, cleaning and scoring multiple-choice-question corpora."""
