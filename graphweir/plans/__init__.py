"""Plan-level helpers: sessions, durable intermediate tables, fixpoint loops."""
