"""Spark-first analytics engine for collections of mixed-source documents."""
