"""Tables in the folder that the cluster shares: those of the graph engine."""

from graphprop.tables import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
