"""How plans are run: where intermediate tables go, and iteration to a fixpoint."""
