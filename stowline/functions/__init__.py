"""Part of the pick-flow and slotting engine."""
