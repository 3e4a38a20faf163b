"""Training-data operators (quality, chat, mixing, dedup, filters, extraction, decontamination)."""
