"""kmerloom: genome-sketch analytics and set/relational operators on Spark DataFrames."""

__version__ = "0.1.0"
