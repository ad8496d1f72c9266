"""Update planning and the SQL surface."""
