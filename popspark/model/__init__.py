"""Small dense numerics: demographies, hidden intervals, transition and emission tables, forward and backward passes."""
