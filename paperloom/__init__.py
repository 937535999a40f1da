"""paperloom: document analytics over whole collections, on PySpark."""
