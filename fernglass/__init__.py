"""fernglass: Spark-native analysis of annotated plan images, colour legends and plant names."""
