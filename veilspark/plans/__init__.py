"""Plans over whole tables: rules, the masking plan of a table, the mask-and-validate run."""
