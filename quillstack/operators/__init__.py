"""DataFrame -> DataFrame operators; nothing here triggers a job unless its docstring says so."""
