"""Part of the tallyfield engine."""
