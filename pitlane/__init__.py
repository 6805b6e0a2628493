"""Point-in-time analytics and ranking evaluation as Spark DataFrame operators."""
