"""lodestone: analytics over repository graphs and text corpora, written for Spark."""
