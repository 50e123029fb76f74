"""Payment-ledger risk analytics as Spark DataFrame operators."""
