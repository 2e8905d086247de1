"""Where usage comes from: agents' log files and databases."""
