"""Corporate risk scoring, model monitoring and text evaluation as Spark plans."""
