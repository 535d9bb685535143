"""ledgerloom: payment reconciliation and event analytics as DataFrame programs on Spark."""

__version__ = "0.1.0"
