"""issuelake: DataFrame-first analytics over repositories, issues and code chunks."""

__version__ = "0.1.0"
