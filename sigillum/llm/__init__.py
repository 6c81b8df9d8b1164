"""Operations of a training-data pipeline, each as Spark jobs over whole tables."""
