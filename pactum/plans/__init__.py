"""From typed trees to DataFrame plans: one row per record, or one DataFrame per list of records."""
