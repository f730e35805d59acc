"""Panel construction, features, splits, models, evaluation and portfolios."""
