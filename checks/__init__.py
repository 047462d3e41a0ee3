"""Reference SQL for the registered queries."""
