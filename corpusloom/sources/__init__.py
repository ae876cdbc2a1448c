"""Sources and sinks of the question-answering corpus."""
