"""What reads, merges, prunes, writes and maintains tables."""
