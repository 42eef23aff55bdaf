"""flowlens: network-traffic analytics and intrusion detection on Spark DataFrames."""
