"""Ready-made questions: the report API, the registered queries and their SQL counterparts."""
