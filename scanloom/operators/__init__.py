"""DataFrame operators: file profile, line rules, token rules, risk, merge, grouping, model tables."""
