"""From text to a bound query: tokens, grammar, names and types, and the plan that explain shows."""
