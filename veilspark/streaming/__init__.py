"""Stateful forms of the session store."""
