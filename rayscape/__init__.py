"""A Spark-native engine for mapping cities from satellite-navigation measurements."""

from rayscape.operators.observe import observe
from rayscape.operators.predict import predict
from rayscape.operators.simulate import simulate
from rayscape.sources.gnsslogger import read_gnsslogger

__all__ = ["observe", "predict", "read_gnsslogger", "simulate"]
