"""Analytics over ordered key-value logs, byte streams, snapshot logs and files, written as Spark DataFrame plans."""
