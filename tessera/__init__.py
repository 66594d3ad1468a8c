"""tessera: media-library analytics expressed as Spark DataFrame plans."""
