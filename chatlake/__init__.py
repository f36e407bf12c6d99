"""chatlake: Spark jobs over agent conversations, run logs and training text."""
