"""borelake: Spark jobs over depth-indexed borehole logs."""
