"""Writers: text series, line protocol, tables and model parameters."""
