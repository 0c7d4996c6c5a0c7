"""Table operators: cleaning, imputation, panels, indicators, checks, figures."""
