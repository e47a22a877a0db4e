"""Where domain tables come from."""
