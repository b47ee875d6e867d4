"""Language-model providers, their prompts and replies, and answers to questions about a model."""
