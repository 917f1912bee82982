"""Where the sample tables lie."""

SF = "/root/testdata/sf0.001"
