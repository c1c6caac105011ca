"""Term validation on Spark: vocabularies, enumerations and checks as DataFrame plans."""

__version__ = "0.1.0"
