"""Portfolio selection and evaluation as Spark plans over long price tables."""
