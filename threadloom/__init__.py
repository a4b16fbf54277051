"""Analytics over coding-agent session transcripts, as Spark plans."""
