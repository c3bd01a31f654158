"""The composite operators: preparation, observation levels, evaluation, event alignment."""
