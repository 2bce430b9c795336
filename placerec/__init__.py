"""placerec: Spark-native place-recognition retrieval and trajectory analytics."""
