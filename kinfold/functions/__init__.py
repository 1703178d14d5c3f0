"""functions of kinfold."""
