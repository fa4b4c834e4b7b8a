"""Tables read and written: pages, dimensions, snapshots, sheets."""
