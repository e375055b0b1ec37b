"""Spark-native geostatistical seismic inversion and reservoir-model conditioning."""
