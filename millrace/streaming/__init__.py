"""Extensions over streams; the batch operators apply to static frames."""
