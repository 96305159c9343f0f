"""Training-data operators: quality, deduplication, decontamination, secrets, tokens, pages and chats."""
