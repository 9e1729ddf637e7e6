"""A deductive (Datalog) analytics engine that compiles to Spark DataFrames."""
