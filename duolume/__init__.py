"""Analytics over detection experiments and paired visible/thermal images, as Spark DataFrame operators."""
