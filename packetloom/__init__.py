"""Network-flow analytics as Spark DataFrame operators."""

from packetloom.params import Params

__all__ = ["Params"]
