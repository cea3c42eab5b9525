"""DataFrame -> DataFrame operators: frames (F*), runs (R*), tables (G*)."""
