"""tessera: catalogue reconciliation and analytics as PySpark DataFrame operators."""
