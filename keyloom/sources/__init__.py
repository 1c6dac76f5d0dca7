"""Where keyed tables come from and go to."""
