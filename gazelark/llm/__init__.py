"""Training-data operators: each module holds one operator, its query and its oracle SQL."""
