"""Multiple-choice and numeric question data, and the replies to it, as Spark DataFrame work."""
