"""Spark jobs over labelled series, shapelets and label streams."""
