"""DataFrame-to-DataFrame operators on ordered measurement series. `key` names the columns of one series."""
