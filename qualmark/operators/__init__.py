"""DataFrame operators (label statistics, prompts, voting, sampling, metrics, models)."""
