"""ticketloom: a Spark-native engine for support-ticket analytics."""

__version__ = "0.1.0"
