"""The registered queries: name -> callable(spark, sf_dir), and the SQL that checks them."""
