"""Row, aggregate and join operators on event frames."""
