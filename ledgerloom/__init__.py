"""Accounts-payable reconciliation as Spark DataFrame operators."""
