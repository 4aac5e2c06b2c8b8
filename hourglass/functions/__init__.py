"""Column helpers: nested paths and array folds (nested), code rules and value sets (codes), dates."""
