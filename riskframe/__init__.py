"""riskframe: credit-risk style analytics as PySpark DataFrame operators."""
