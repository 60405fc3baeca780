"""Tables, logs and snapshots."""
