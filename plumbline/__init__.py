"""From raw tables to an honestly diagnosed model, as Spark DataFrame operators."""
