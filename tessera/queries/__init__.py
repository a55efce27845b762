"""Named queries over the relational tables and the SQL that checks them."""
