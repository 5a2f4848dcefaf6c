"""DataFrame operators. Unless a docstring says otherwise they work on batch and streaming frames alike."""
