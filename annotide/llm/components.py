"""Connected components of the training-data operators: minimum labels, pointer jumping and numbers without collisions."""

from annotide.operators.components import Numbers, minimum_labels, numbered

__all__ = ["Numbers", "minimum_labels", "numbered"]
