"""chalkline: lecture-corpus analytics as PySpark DataFrame functions."""
