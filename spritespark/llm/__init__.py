"""Training-data operators over text corpora; nothing outside this subpackage imports it."""
