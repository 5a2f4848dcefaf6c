"""Where rows go. Every writer is keyed by the batch id, so a repeated batch replaces itself."""
