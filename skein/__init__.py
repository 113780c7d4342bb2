"""skein: conversation and text-corpus analytics expressed as Spark plans."""
