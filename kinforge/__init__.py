"""kinforge: entity resolution and the analytics around it, as Spark plans."""
